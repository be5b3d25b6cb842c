"""Suffix-array dedup by threshold-bounded interval expansion.

Byte strings of ``LENGTH`` bytes that stand twice are found on a Burrows-Wheeler transform.
Every string of LENGTH bytes elects an anchor, so strings that are alike lie in segments of one
anchor, and each anchor's segments are a part of the text on which the whole method can run.
Different segments that share an anchor (:mod:`.seeds`) are set end to end, sorted by suffix, and the
transform is expanded breadth first: level by level, every interval of suffixes that start
with one pattern is extended by one byte to the left.  An interval of a pattern of n bytes that
ends where no boundary was known marks one there: the two suffixes share n - 1 bytes.  Common
prefixes are so derived by increasing value, and the expansion stops at LENGTH: where no
boundary is marked by then, neighbours share at least that many bytes.

Defined cases: a null or empty text has no bytes; a text of fewer than LENGTH bytes keeps all;
repeated rows (alike in id and text) are one document and get equal results; a null id comes
after all others; a very long text is one slice of its block and sends segments like any other;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from lorebase.llm.seeds import GROUP, removed_spans

LENGTH, GRAM = 100, 32


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of their suffixes, exact to ``depth`` symbols at least, by prefix doubling."""
    n, rank, step = len(symbols), symbols.astype(np.int64), 1
    # Four symbols at a time to begin with.
    for _ in range(2):
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = rank * (int(rank.max()) + 2) + after
        step *= 2
        if step < 4:
            continue
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(rank[order][1:] != rank[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if step >= depth or new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


def boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where neighbours in suffix order share fewer than ``length`` symbols (0 parts texts and is never shared).

    marked[i]: between suffixes i - 1 and i.
    """
    n = len(symbols)
    last = symbols[order - 1]
    # Where each suffix goes when its preceding symbol is put before it; and the next suffix on either side with that symbol.
    by_symbol = np.argsort(last, kind="stable")
    goes = np.empty(n, np.int64)
    goes[by_symbol] = np.arange(n)
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    same = last[by_symbol][1:] == last[by_symbol][:-1]
    before[by_symbol[1:][same]], after[by_symbol[:-1][same]] = by_symbol[:-1][same], by_symbol[1:][same]
    marked = np.zeros(n + 1, dtype=bool)
    marked[0] = marked[n] = True
    low, high, level = np.array([0]), np.array([n]), 0
    while len(low) and level < length:
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        if level:
            use = last[place] != 0
            owner, place = owner[use], place[use]
        first, final = before[place] < low[owner], after[place] >= high[owner]
        low, high = np.sort(goes[place[first]]), np.sort(goes[place[final]]) + 1
        level += 1
        new = ~marked[high]
        marked[high] = True
        low, high = low[new], high[new]
    return marked[:n]


def expanded(length: int):
    """Windows that segments share, by the transform of all segments of many anchors."""

    def shared(groups: list[list[tuple]]) -> Iterator[tuple[tuple, int, int]]:
        firsts = [first for group in groups for first in group]
        if not firsts:
            return
        segments = [np.frombuffer(first[0], np.uint8) for first in firsts]
        sizes = np.array([len(s) + 1 for s in segments])
        starts = np.cumsum(sizes) - sizes
        symbols = np.zeros(int(sizes.sum()), np.int64)
        for at, s in zip(starts.tolist(), segments, strict=True):
            symbols[at : at + len(s)] = s
            symbols[at : at + len(s)] += 1
        order = suffix_array(symbols, length)
        class_ = np.cumsum(boundaries(symbols, order, length))
        owner = np.searchsorted(starts, order, side="right") - 1
        inside = order - starts[owner]
        window = np.flatnonzero(inside + length < sizes[owner])
        class_, owner, inside = class_[window], owner[window], inside[window]
        ord_, tie_, start = (np.array([first[c] for first in firsts]) for c in (2, 3, 4))
        rank = np.lexsort((start[owner] + inside, tie_[owner], ord_[owner], class_))
        again = rank[1:][class_[rank][1:] == class_[rank][:-1]]
        again = again[np.lexsort((inside[again], owner[again]))]
        # Neighbouring windows are one stretch.
        owner, inside = owner[again], inside[again]
        if not len(owner):
            return
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)))
        last = np.append(new[1:], len(owner)) - 1
        for o, x, y in zip(owner[new].tolist(), inside[new].tolist(), inside[last].tolist(), strict=True):
            yield firsts[o], x, y - x + length

    return shared


def finish(raw: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a].tobytes())
        at = b
    kept.append(raw[at:].tobytes())
    left = b"".join(kept)
    return len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = GROUP) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    result = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return removed_spans(docs, expanded(length), False, length, gram, finish, result, id_col, text_col, most)
