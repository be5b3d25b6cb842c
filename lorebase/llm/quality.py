"""Quality rules as weak supervision.

Each rule looks at one document and votes ``+1`` (clean), ``-1`` (junk) or abstains (``0``).
No vote decides alone: documents are grouped by their pattern of votes, expectation-
maximisation over the pattern counts estimates how often each rule casts each vote on clean
and on junk documents (its accuracies) together with the share of clean documents, and the
posterior probability of being clean takes the place of all-must-pass filtering.

There are at most ``3 ** len(RULES)`` patterns whatever the number of documents, so only that
many counts reach the driver; everything by document is DataFrame expressions.

Defined cases: a null or empty text has no words, so ``base_failed`` is true and ``kept`` is
false; repeated rows and equal texts get equal results; a very long text is one row's arrays of
words and windows; a null id stays null; an empty table gives an empty result; other columns,
whatever their names, are ignored, and :func:`keep_clean` carries them inside one column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.arrow import text_or_empty
from lorebase.storage import materialise

#: The characters that part words, as a class and as they are; and those that count as symbols.
SPACE, SPACES, SYMBOLS = r"\x20\x09-\x0D", " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Start of the expectation-maximisation: share of clean documents, and how often a rule that votes finds a clean and a junk document clean.
PRIOR, CLEAN, JUNK = 0.85, 0.97, 0.5
#: What weak supervision takes for granted of a rule: of its votes against documents at least this share is right.
MIN_ACCURACY = 0.85
ITERATIONS, SMOOTHING = 25, 1.0


def signals(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """What the rules look at, by document, beside the columns of ``keep``.

    To be written before it is filtered: a filter would be pushed below the projections and
    compute the signals again.
    """
    text = text_or_empty(docs[text_col])
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))
    first = docs.select(*keep, text.alias("_text"), words.alias("_w"))
    names = [c for c in first.columns if c not in ("_text", "_w")]
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    # A window of three words by its hash and its place.
    windows = F.expr("transform(slice(_w, 1, size(_w) - 2), (w, i) -> struct(xxhash64(w, _w[i + 1], _w[i + 2]) as h, i as i))")
    second = first.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        matched(F.col("_text"), SYMBOLS).alias("n_symbols"),
        matched(F.col("_text"), "!?").alias("n_marks"),
        matched(F.col("_text"), "A-Z").alias("n_capitals"),
        lines.alias("_lines"),
        F.when(F.size("_w") >= 3, F.sort_array(windows)).alias("_s"),
    )
    third = second.select(
        *names, "n_words", "word_chars", "n_symbols", "n_marks", "n_capitals",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_s",
    )
    # Neighbours in hash order that are equal are found twice or more; their places in order say how many words they cover.
    equal = F.when(F.size("_s") > 1, F.expr("filter(sequence(1, size(_s) - 1), k -> _s[k].h = _s[k - 1].h)"))
    fourth = third.withColumn("_k", equal)
    places = F.expr("array_sort(array_distinct(flatten(transform(_k, k -> array(_s[k - 1].i, _s[k].i)))))")
    fifth = fourth.withColumn("_p", F.when(F.size("_k") > 0, places)).drop("_k", "_s")
    covered = F.expr("3 + aggregate(sequence(1, size(_p) - 1), 0, (n, k) -> n + least(3, _p[k] - _p[k - 1]))")
    repeats = F.when(F.size("_p") > 1, covered).otherwise(0).cast("long")
    return fifth.select("*", repeats.alias("n_repeat_words")).drop("_p")


def matched(text: Column, characters: str) -> Column:
    """How many characters of the text are of a class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _vote(junk: Column, clean: Column) -> Column:
    return F.when(junk, -1).when(clean, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules, by name, over the columns of :func:`signals`."""
    c = F.col
    return {
        "symbols": _vote(c("n_symbols") * 20 > c("word_chars"), c("n_symbols") * 200 <= c("word_chars")),
        "shouting": _vote(c("n_capitals") * 10 > c("word_chars") * 4, c("n_capitals") * 10 <= c("word_chars")),
        "marks": _vote(c("n_marks") * 2 > c("n_words"), c("n_marks") * 10 <= c("n_words")),
        "repeated_words": _vote(c("n_repeat_words") * 10 > c("n_words") * 4, c("n_repeat_words") * 5 <= c("n_words")),
        "repeated_lines": _vote(c("n_dup_lines") * 2 > c("n_lines"), c("n_dup_lines") * 10 <= c("n_lines")),
        "word_length": _vote((c("word_chars") > c("n_words") * 14) | (c("word_chars") < c("n_words") * 2), c("word_chars") <= c("n_words") * 9),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def estimate(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over vote patterns: the prior log-odds of clean, and by rule what each vote adds to them."""
    m, order, total = len(next(iter(patterns), ())), sorted(patterns.items()), sum(patterns.values())
    prior, clean, junk = PRIOR, [CLEAN] * m, [JUNK] * m
    for _ in range(ITERATIONS if total else 0):
        odds, add = math.log(prior / (1 - prior)), weights(clean, junk)
        share = [1 / (1 + math.exp(-max(-700, min(700, odds + sum(add[j][v] for j, v in enumerate(votes)))))) for votes, _ in order]
        good = sum(p * n for p, (_, n) in zip(share, order, strict=True))
        prior = (good + SMOOTHING * PRIOR) / (total + SMOOTHING)
        for j in range(m):
            cast = [(votes[j] > 0, p * n, (1 - p) * n) for p, (votes, n) in zip(share, order, strict=True) if votes[j]]
            clean[j] = (sum(c for up, c, _ in cast if up) + SMOOTHING * CLEAN) / (sum(c for _, c, _ in cast) + SMOOTHING)
            junk[j] = (sum(b for up, _, b in cast if up) + SMOOTHING * JUNK) / (sum(b for _, _, b in cast) + SMOOTHING)
            wrong = (1 - junk[j]) * (1 - prior) / prior * (1 - MIN_ACCURACY) / MIN_ACCURACY
            clean[j] = max(clean[j], 1 - wrong)
    return math.log(prior / (1 - prior)), weights(clean, junk)


def weights(clean: list[float], junk: list[float]) -> list[dict[int, float]]:
    """By rule, what each vote adds to the log-odds of clean; an abstention says nothing."""
    return [{-1: math.log((1 - a) / (1 - b)), 0: 0.0, 1: math.log(a / b)} for a, b in zip(clean, junk, strict=True)]


def learned(found: DataFrame) -> Column:
    """The posterior probability of being clean, as a column over :func:`signals`, learned from all rows of ``found``.

    Rows that fail the base rules don't take part: their verdict is fixed.
    """
    by_name = rules()
    votes = [rule.alias(k) for k, rule in by_name.items()]
    counted = found.filter(~base_failed()).select(*votes).groupBy(*by_name).agg(F.count(F.lit(1)).alias("n")).collect()
    odds, add = estimate({tuple(r[k] for k in by_name): r["n"] for r in counted} or {(0,) * len(by_name): 0})
    total = F.lit(odds)
    for (_, rule), weight in zip(by_name.items(), add, strict=True):
        total = total + F.when(rule < 0, weight[-1]).when(rule > 0, weight[1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: the signals, base_failed, the probability of being clean, and kept."""
    found = materialise(signals(docs, text_col, docs[id_col].alias("doc_id")), "quality-signals")
    out = found.withColumn("base_failed", base_failed()).withColumn("p_clean", learned(found))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_clean") >= threshold))


def keep_clean(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns."""
    packed = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    # Signals cost more than writing the rows beside them once.
    found = materialise(signals(docs, text_col, packed), "quality-signals")
    return found.filter(~base_failed() & (learned(found) >= threshold)).select("_row.*")
