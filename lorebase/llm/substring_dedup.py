"""Substring dedup by seed and extend.

Documents meet on winnowed anchors of ``GRAM`` words (:mod:`.seeds`); from a shared anchor the
match is extended to the left and to the right, word by word, and kept if it spans ``LENGTH``
words or more.  Each word covered by a kept match that also stands earlier is removed.

Defined cases: a null, empty or blank text has no words; a text of fewer than LENGTH words
keeps all; repeated rows (alike in id and text) are one document and get equal results; a null
id comes after all others; a very long text is one slice of its block and sends segments like any
other; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from lorebase.llm.seeds import GROUP, Units, removed_spans

LENGTH, GRAM = 20, 8


def extended(length: int):
    """Segments of an anchor, extended both ways from it, all of them together.

    Word by word, segments that have agreed so far part into classes: by what stands before the
    anchor, and by what begins at it.  A window that reaches k words back is the same in all
    segments of one class k words before and one class length - k words on.
    """

    def shared(groups: list[list[tuple]]) -> Iterator[tuple[tuple, int, int]]:
        for group in groups:
            before, after, least, windows = {}, {}, {}, []
            for first in group:
                words, p, place = first[0].split(b" "), first[5], first[2:5]
                left, node = [0], 0
                for w in words[p - 1 :: -1] if p else ():
                    node = before.setdefault((node, w), len(before) + 1)
                    left.append(node)
                right, node = [0], 0
                for w in words[p : p + length]:
                    node = after.setdefault((node, w), len(after) + 1)
                    right.append(node)
                own = [(left[p - x], right[length - p + x]) for x in range(len(words) - length + 1)]
                windows.append(own)
                for x, window in enumerate(own):
                    at = (*place[:2], place[2] + x)
                    if window not in least or at < least[window]:
                        least[window] = at
            for first, own in zip(group, windows, strict=True):
                o, t, start = first[2:5]
                again = [least[window] != (o, t, start + x) for x, window in enumerate(own)]
                x = 0
                while x < len(again):
                    y = x
                    while y < len(again) and again[y]:
                        y += 1
                    if y > x:
                        yield first, x, y - x - 1 + length
                    x = y + 1

    return shared


def finish(raw: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, str, str]:
    units = Units(raw, np.array([0, len(raw)]), True)
    keep = np.ones(len(units), dtype=bool)
    for a, b in spans:
        keep[a:b] = False
    all_ = raw.tobytes()
    kept = b" ".join([all_[a:b] for a, b in zip(units.first[keep].tolist(), units.last[keep].tolist(), strict=True)])
    return len(units), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, payload: bool = True, most: int = GROUP) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and, with ``payload``, the kept words joined by one space."""
    result = "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * payload
    return removed_spans(docs, extended(length), True, length, gram, finish if payload else lambda raw, spans: finish(raw, spans)[:3], result, id_col, text_col, most)
