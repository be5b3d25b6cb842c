"""Helpers for Arrow-batched stages: texts in, columns out, in bounded slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a Python stage works on at once; a single longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that matter, under fixed names; a null text counts as empty."""
    return docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by bytes of text, so that memory is bounded by ``limit`` and the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def unsliced(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A copy whose offsets begin at 0: kernels read what was cast from a slice at the wrong place."""
    return pa.concat_arrays(column.chunks if isinstance(column, pa.ChunkedArray) else [column])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the offsets of its rows in them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    own = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[own[0] : own[-1]], own - own[0]


def map_slices(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with ``work`` applied to each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield work(part)

    return docs.mapInArrow(run, schema)
