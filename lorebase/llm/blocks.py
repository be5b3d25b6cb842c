"""Documents dealt out to blocks of bounded size.

A block is a set of documents, drawn by a hash of the row, of about ``BLOCK_BYTES`` of text.
Stages that need something from the whole corpus for each document exchange it by block: a
block asks once for what any of its documents needs, so what travels is far less than a row for
each document and word, and no frequent word, line or passage gathers more than one row from
each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.arrow import text_or_empty

BLOCK_BYTES = 12_000_000
#: A block is made no smaller than this only to have one for each task.
LEAST_BYTES = 250_000


def blocks_for(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES, spread: bool = False) -> int:
    """How many blocks the texts need; with ``spread`` about as many as there are tasks after a shuffle, if that is more."""
    total = docs.agg(F.sum(F.octet_length(text_or_empty(docs[text_col]))).alias("b")).first()["b"] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if spread else 1
    return int(max(total // block_bytes, min(tasks - 1, total // LEAST_BYTES))) + 1


def dealt(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, *more: Column, spread: bool = False) -> DataFrame:
    """(block, doc_id, text) of every row, and the columns ``more``; a null text counts as empty."""
    n = blocks_for(docs, text_col, block_bytes, spread)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"), *more)
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), *rows.columns)
