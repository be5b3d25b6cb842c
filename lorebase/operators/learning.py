"""What is learned from tables: sampled posteriors, a word classifier, and rules for entities.

All of it is expressions and aggregates.  Defined cases: nulls are named at each function; ties go
to the smaller name; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- posteriors ---------------------------------------------------------------------------------


def uniform(*counter: Column | int) -> Column:
    """A number in (0, 1) for a counter: the same for the same counter, wherever and whenever it is drawn."""
    bits = F.shiftrightunsigned(F.xxhash64(*[c if isinstance(c, Column) else F.lit(c) for c in counter]), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _gamma(shape: Column, key: Column, draw: Column, side: int, tries: int = 5) -> Column:
    """A draw from Gamma(shape): by rejection with shape + 1, scaled down by a power of a uniform number.

    Each try is a counter of its own; one in 20 is rejected at worst, all ``tries`` one time in
    3,000,000, when the last one counts.
    """
    d = shape + 1 - 1 / 3
    c = 1 / F.sqrt(9 * d)
    out = None
    for i in reversed(range(tries)):
        z = F.sqrt(-2 * F.ln(uniform(key, draw, side, i, 0))) * F.cos(2 * math.pi * uniform(key, draw, side, i, 1))
        cubed = F.pow(1 + c * z, F.lit(3.0))
        v = F.when(cubed > 0, cubed)
        good = F.ln(uniform(key, draw, side, i, 2)) < z * z / 2 + d - d * v + d * F.ln(v)
        value = d * F.coalesce(v, F.lit(1.0))
        out = value if out is None else F.when(good, value).otherwise(out)
    return out * F.pow(uniform(key, draw, side, -1), 1 / shape)


def sampled_posteriors(rows: DataFrame, a: str, b: str, draws: int = 4000, seed: int = 7, at: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """(a, b, mean, deviation, low, high) of every distinct Beta(a, b), by Monte Carlo: mean, standard deviation and two quantiles of ``draws`` draws.

    Draws are numbered and each is a function of (seed, a, b, its number), so a lost task draws the same again.
    They are summed up by partial aggregates; exact quantiles of so many draws fit into one buffer.  A null
    or a parameter of 0 or less has no posterior and is left out.
    """
    each = rows.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a > 0 and b > 0").distinct()
    drawn = each.select("a", "b", F.xxhash64("a", "b", F.lit(seed)).alias("key"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    x = drawn.withColumns({"x": _gamma(F.col("a"), F.col("key"), F.col("draw"), 1), "y": _gamma(F.col("b"), F.col("key"), F.col("draw"), 2)})
    share = x.select("a", "b", (F.col("x") / (F.col("x") + F.col("y"))).alias("p"))
    return share.groupBy("a", "b").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("deviation"), F.percentile("p", [float(q) for q in at]).alias("q")).select("a", "b", "mean", "deviation", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


# -- a classifier of texts ----------------------------------------------------------------------


def words_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word) of the distinct words of each text, in lower case; a null text has none."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    return df.select(F.col(id_col).alias("id"), F.explode(words).alias("word"))


def word_weights(labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Naive Bayes of a label (0 or 1; others are left out): (word, weight) and one row (prior, absent).

    The labelled rows are a bounded sample by choice of the caller.  A word's weight is what its presence adds to
    the log odds of label 1 instead of its absence; ``prior`` holds the log odds of a text without any known word.
    """
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    size = rows.agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))  # one row
    counts = words_of(rows, "id", "text").join(rows.select("id", "label"), "id").groupBy("word").agg(F.sum("label").alias("in1"), F.sum(1 - F.col("label")).alias("in0"))
    p1, p0 = (F.col("in1") + 1) / (F.col("ones") + 2), (F.col("in0") + 1) / (F.col("zeros") + 2)
    each = counts.crossJoin(F.broadcast(size)).select("word", (F.ln(p1 / p0) - F.ln((1 - p1) / (1 - p0))).alias("weight"), F.ln((1 - p1) / (1 - p0)).alias("without"))
    prior = each.agg(F.coalesce(F.sum("without"), F.lit(0.0)).alias("without")).crossJoin(size).select((F.col("without") + F.ln((F.col("ones") + 1) / (F.col("zeros") + 1))).alias("prior"))
    return each.select("word", "weight"), prior


def classified_texts(df: DataFrame, id_col: str, text_col: str, weights: DataFrame, prior: DataFrame) -> DataFrame:
    """(id, log_odds, label) of every row: the prior and the weights of the words that it has."""
    sums = words_of(df, id_col, text_col).join(weights, "word").groupBy("id").agg(F.sum("weight").alias("w"))
    scored = df.select(F.col(id_col).alias("id")).join(sums, "id", "left").crossJoin(F.broadcast(prior))
    odds = F.coalesce("w", F.lit(0.0)) + F.col("prior")
    return scored.select("id", odds.alias("log_odds"), (odds > 0).cast("int").alias("label"))


# -- rules for entities -------------------------------------------------------------------------

#: Generalisations of a token, from the closest to the widest, by the classes that its letters and digits fall into: letter by letter, then by runs.
CLASSES = [("[A-Z]", "[a-z]", "[0-9]"), ("[A-Z]", "[a-z]", "[0-9]"), ("[A-Za-z]", "[0-9]"), ("[A-Za-z0-9]",)]
LEVELS = len(CLASSES)


def shape(token: Column, level: int) -> Column:
    """A token's pattern at a level, as a regular expression: classes for letters and digits, all else as it is."""
    out = token
    # Marks from the private use area stand for the classes until all else is quoted.
    for i, of in enumerate(CLASSES[level]):
        out = F.regexp_replace(out, of, chr(0xE000 + i))
    out = F.regexp_replace(out, r"([!-/:-@\[-`{-~])", r"\\$1")
    for i, of in enumerate(CLASSES[level]):
        out = F.regexp_replace(out, chr(0xE000 + i) + ("+" if level else ""), of + ("+" if level else ""))
    return out


def learned_rules(spans: DataFrame, token: str, label: str, support: int = 5, precision: float = 0.9) -> DataFrame:
    """(pattern, entity_type, level, support, precision): rules from labelled tokens; a null label marks a token that is no entity.

    Tokens are aligned by their shapes: those of one shape are one rule.  A rule counts with ``support`` tokens
    of a type and if that type's part of all tokens of the shape is ``precision``; of the rules of one type those stay
    that no wider rule of the type covers.
    """
    tokens = spans.groupBy(F.col(token).alias("token"), F.col(label).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    levels = tokens.select("token", "entity_type", "n", F.posexplode(F.array(*[shape(F.col("token"), i) for i in range(LEVELS)])).alias("level", "pattern"))
    by_type = levels.groupBy("level", "pattern", "entity_type").agg(F.sum("n").alias("support"))
    every = by_type.groupBy("level", "pattern").agg(F.sum("support").alias("all"))
    good = by_type.filter("entity_type is not null").join(every, ["level", "pattern"]).withColumn("precision", F.col("support") / F.col("all")).filter((F.col("support") >= support) & (F.col("precision") >= precision))
    # A token's widest good rule; what no token has as its widest is covered.
    best = levels.join(good.select("level", "pattern", "entity_type"), ["level", "pattern", "entity_type"]).groupBy("token", "entity_type").agg(F.max(F.struct("level", "pattern")).alias("w"))
    kept = best.select("w.level", "w.pattern", "entity_type").distinct()
    return good.join(kept, ["level", "pattern", "entity_type"]).select("pattern", "entity_type", "level", "support", "precision")


def rule_quality(spans: DataFrame, token: str, label: str, rules: DataFrame) -> DataFrame:
    """(entity_type, found, right, present, precision, recall) of rules on labelled tokens, by shape; a token takes its most precise rule."""
    tokens = spans.groupBy(F.col(token).alias("token"), F.col(label).alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    levels = tokens.select("token", "truth", "n", F.posexplode(F.array(*[shape(F.col("token"), i) for i in range(LEVELS)])).alias("level", "pattern"))
    w = Window.partitionBy("token", "truth").orderBy(F.col("precision").desc(), F.col("support").desc(), "entity_type")
    said = levels.join(rules, ["level", "pattern"]).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("token", "truth", "n", "entity_type")
    found = said.groupBy("entity_type").agg(F.sum("n").alias("found"), F.sum(F.when(F.col("truth") == F.col("entity_type"), F.col("n")).otherwise(0)).alias("right"))
    present = tokens.filter("truth is not null").groupBy(F.col("truth").alias("entity_type")).agg(F.sum("n").alias("present"))
    both = present.join(found, "entity_type", "full").select("entity_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "right", "present")])
    return both.withColumns({"precision": F.try_divide("right", "found"), "recall": F.try_divide("right", "present")})
