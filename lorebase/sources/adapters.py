"""Sources by name: what turns a column of raw content into rows.

An adapter takes a DataFrame, the name of its raw column and the columns to keep.  New ones are
added with :func:`add`; :func:`ingest` calls one by name.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.operators import text as T
from lorebase.sources import chat, mail


class Adapter(Protocol):
    def __call__(self, df: DataFrame, raw: str, *keep: str) -> DataFrame: ...


def transcript(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """keep: one column, the transcript's key."""
    return T.segments(T.transcript(df, raw, keep[0]), keep[0])


def document(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """Sections of a document, by the format it is in; keep: one column, the document's key."""
    key = keep[0]
    marked = df.withColumn("_marked", T.is_markdown(F.col(raw)))
    one = T.markdown_sections(marked.filter("_marked"), raw, key).select(key, "section", "title", "body")
    return one.unionByName(T.plain_sections(marked.filter("not _marked"), raw, key).select(key, "section", "title", "body"))


_known: dict[str, Adapter] = {"slack": chat.slack, "discord": chat.discord, "teams": chat.teams, "mail": mail.emails, "news": mail.articles, "transcript": transcript, "document": document}


def add(name: str, adapter: Adapter) -> None:
    _known[name] = adapter


def names() -> list[str]:
    return sorted(_known)


def ingest(kind: str, df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """Raw content of a kind as rows; an unknown kind is an error."""
    if kind not in _known:
        raise ValueError(f"unknown source {kind!r}; there are {', '.join(names())}")
    return _known[kind](df, raw, *keep)
