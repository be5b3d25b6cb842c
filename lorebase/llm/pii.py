"""Personal data: expressions propose, validators confirm, context adjusts.

Regular expressions propose spans; checksum validators (Luhn for cards, mod-97 for bank
accounts, ranges for addresses) confirm them; words nearby raise or lower a span's score.
The four base kinds keep every confirmed span whatever its score.  The kinds that the method
adds (``iban``, ``ssn``, ``secret``) are reported only at a score of ``THRESHOLD`` or more.

All of it is DataFrame expressions.  Offsets are code points: the text is split by the same
expression that finds the matches, and the lengths of gaps and matches are added up.  A text
in which an expression finds nothing costs one scan by that expression.

The expressions are possessive and may begin a match only where a run of their first
characters begins (or where the match before ended), so that a long run costs linear time and
no stack; the matches are those of the plain expressions.

Defined cases: a null or empty text has no spans, counts of 0 and the digest of the empty
string; a very long text is searched as a whole, in one row; repeated rows get equal results; a
null id stays null; an empty table gives an empty result; other columns, whatever their names,
are ignored, and :func:`redact` keeps them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.arrow import text_or_empty

# How long the account numbers of each country are (ISO 13616).
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_ACCOUNT = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTH.items())
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Kinds in the order of the result: the base ones, then those that the method adds.
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn", "secret")
PROPOSE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_ACCOUNT})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Za-z_]{32,}+(?![A-Za-z0-9])",
}
#: A cheap test that any match of the kind passes.
HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")) & t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "secret": lambda t: t.rlike(r"[0-9A-Za-z_]{32}"),
}
#: Score of a confirmed span before its context, and the words that speak for it or against it.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.85, "ssn": 0.4, "secret": 0.4}
FOR = {
    "email": "mail|contact|reach", "ip": "address|host|server", "card": "card|visa|payment|credit", "phone": "phone|call|tel|mobile",
    "iban": "iban|bank|account|konto|cuenta|compte", "ssn": "ssn|social|security", "secret": "token|secret|password|api|key",
}
AGAINST = {
    "email": "example only", "ip": "version|release", "card": "order|serial|tracking", "phone": "fax code",
    "iban": "example only", "ssn": "part|serial|order", "secret": "sha256|digest|checksum|commit",
}
AROUND, STEP, THRESHOLD = 40, 0.3, 0.6


def matches(text: Column, expression: str) -> Column:
    """All matches as an array of (s, e, m): start and end in code points, and the match."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("m"), F.split(text, expression, -1).alias("g"))
    zero = F.expr("named_struct('p', 0, 'out', cast(array() as array<struct<s: int, e: int, m: string>>))")

    def step(acc: Column, x: Column) -> Column:
        start = acc["p"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("p"), F.array_append(acc["out"], span).alias("out")))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    each = F.transform(characters(F.reverse(number)), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, without blanks, has a remainder of 1."""
    moved = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    values = F.transform(characters(moved), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda s, v: (F.when(v > 9, s * 100).otherwise(s * 10) + v) % 97) == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONFIRM = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
    "iban": lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))),
    "ssn": lambda m: ~m.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$"),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
}


def confirmed(text: Column, kind: str) -> Column:
    """The spans of a kind as an array of (kind, s, e, score); empty without a hint."""
    found = F.filter(matches(text, PROPOSE[kind]), lambda x: CONFIRM[kind](x["m"]))

    def score(x: Column) -> Column:
        near = F.lower(F.concat(F.substring(text, F.greatest(x["s"] - AROUND, F.lit(0)) + 1, F.least(x["s"], F.lit(AROUND))), F.lit(" "), F.substring(text, x["e"] + 1, F.lit(AROUND))))
        bonus = F.when(near.rlike(rf"\b(?:{FOR[kind]})"), STEP).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{AGAINST[kind]})"), STEP).otherwise(0.0)
        return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(SCORE[kind]) + bonus)), 3)

    spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), score(x).alias("score")))
    spans = F.filter(spans, lambda x: x["score"] >= THRESHOLD) if kind in ADDED else spans
    none = F.expr("cast(array() as array<struct<kind: string, s: int, e: int, score: double>>)")
    return F.when(HINT[kind](text), spans).otherwise(none)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, *keep: Column, text_col: str = "text") -> DataFrame:
    """The spans of each kind as array columns, beside the columns of ``keep``."""
    text = text_or_empty(docs[text_col])
    return docs.select(*keep, *[confirmed(text, k).alias(f"_{k}") for k in (*BASE, *ADDED)])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, digest of their spans, all spans, and all spans with scores."""
    found = find_pii(docs, docs[id_col].alias("doc_id"), text_col=text_col)
    base, every = F.concat(*[f"_{k}" for k in BASE]), F.concat(*[f"_{k}" for k in (*BASE, *ADDED)])
    return found.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(every).alias("spans"),
        every.alias("scored"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one."""
    packed = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    found = find_pii(docs, packed, text_col=text_col)
    every = F.array_sort(F.transform(F.concat(*[f"_{k}" for k in (*BASE, *ADDED)]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    found = found.select("_row", every.alias("_spans"))
    text = F.col(f"_row.`{text_col}`")
    zero = F.struct(F.lit(0).alias("p"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        grown = F.concat(acc["out"], F.substring(text, acc["p"] + 1, x["s"] - acc["p"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.when(x["s"] >= acc["p"], grown).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["p"] + 1, F.length(text))))
    clean = F.when(F.size("_spans") > 0, clean).otherwise(text)
    return found.select(*[(clean if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
