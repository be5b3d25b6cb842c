"""Repeats of a minimum length across documents: seeds, segments, and what to remove.

What op6 (words) and op7 (bytes) have in common.  A text is a sequence of units; a *window*
is ``length`` consecutive units of one text.  Every window elects an *anchor*: of the hashes
of its ``gram`` consecutive units, the smallest (the leftmost on a tie).  The choice depends
on the window's units alone, so all places where a window stands elect the same anchor, about
2 / (length - gram + 2) of all positions are anchors, and a repeated window has a repeated
anchor.

1.  Each block of documents lists its anchors once, with their number; an anchor found twice is
    *repeated*.
2.  Windows that elected one anchor lie side by side: together they are its *segment*.  Each
    block sends the segments of its repeated anchors, alike ones once; the others in the block
    are repeats of the first.
3.  By anchor, alike segments after the first are repeats from end to end.  Segments that
    differ may still share windows: the operator finds them (``shared``), ``GROUP`` different
    segments of an anchor at a time.  An anchor that stands more often is dealt out to several
    tasks and groups, alike segments to the same one; the windows that came first in their group
    are all that is left of it, and they meet by a 128-bit hash, where the first place stays.
4.  Each block gets back which spans of its documents repeat something earlier.

No anchor, segment or window is ever gathered: rows of one anchor stream by in order, in
memory that ``GROUP`` segments bound, and the rows of a hot one lie in many tasks.

Order is by id (null last), then by a hash of the text, then by place.  Rows alike in id and
text are one document and get equal results.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.arrow import slices, text_bytes
from lorebase.llm.blocks import dealt

#: Different segments of one anchor that are compared at once.
GROUP = 1024
LAST = (1 << 63) - 1
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEGMENT = "h bigint, seg binary, block int, ord bigint, tie bigint, start bigint, pre int, parts int"
SPAN = "block int, ord bigint, tie bigint, start bigint, stop bigint, w1 bigint, w2 bigint"
_segment = pa.schema([("h", pa.int64()), ("seg", pa.binary()), ("block", pa.int32()), ("ord", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("pre", pa.int32()), ("parts", pa.int32())])
_span = pa.schema([("block", pa.int32()), ("ord", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])


def rolling(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of symbols[a:b]: equal for equal symbols, wherever they stand."""
    forth = np.full(len(symbols) + 1, _STEP, dtype=np.uint64)
    back = np.full(len(symbols) + 1, _BACK, dtype=np.uint64)
    forth[0] = back[0] = 1
    forth, back = np.multiply.accumulate(forth), np.multiply.accumulate(back)
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * forth[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * back[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys."""
    n = len(keys)
    if n < width:
        return keys[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    table = padded.reshape(-1, width)
    forth = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


class Units:
    """Texts of a slice as one sequence of units. first[i] and last[i]: where unit i lies in raw; offsets: where texts begin, in units."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, words: bool) -> None:
        self.raw, self.words = raw, words
        if not words:
            self.offsets, self.symbols = offsets, None
            return
        part = (raw == 32) | ((raw >= 9) & (raw <= 13))
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = ~part
        begins = inside[1:-1] & ~inside[:-2]
        begins[offsets[:-1][offsets[:-1] < len(raw)]] = inside[1:-1][offsets[:-1][offsets[:-1] < len(raw)]]
        self.first = np.flatnonzero(begins)
        stops = inside[1:-1] & ~inside[2:]
        cut = offsets[1:] - 1
        cut = cut[cut >= 0]
        stops[cut] = inside[1:-1][cut]
        self.last = np.flatnonzero(stops) + 1
        self.offsets = np.searchsorted(self.first, offsets)

    def __len__(self) -> int:
        return int(self.offsets[-1])

    def hashes(self, gram: int) -> np.ndarray:
        """Of each ``gram`` consecutive units."""
        n = len(self)
        if n < gram:
            return np.zeros(0, np.uint64)
        starts = np.arange(n - gram + 1)
        symbols = rolling(_TABLE[self.raw], self.first, self.last) if self.words else _TABLE[self.raw]
        return rolling(symbols, starts, starts + gram)

    def anchors(self, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """By segment: its text's row, its hash, its anchor, and its first and last window."""
        hashes = self.hashes(gram)
        none = np.zeros(0, np.int64)
        if len(hashes) < length - gram + 1:
            return none, none, none, none, none
        keys = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
        elected = (sliding_min(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.searchsorted(self.offsets, np.arange(len(elected)), side="right") - 1
        windows = np.flatnonzero(np.arange(len(elected)) + length <= self.offsets[row + 1])
        if not len(windows):
            return none, none, none, none, none
        a, r = elected[windows], row[windows]
        new = np.ones(len(windows), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(windows)) - 1
        return r[at], hashes[a[at]].view(np.int64), a[at], windows[at], windows[stop]

    def content(self, a: int, b: int) -> bytes:
        """Units a to b: bytes as they are, words joined by one space."""
        if not self.words:
            return self.raw[a:b].tobytes()
        return b" ".join([self.raw[self.first[i] : self.last[i]].tobytes() for i in range(a, b)])


def tie(raw: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(raw.tobytes(), 7)).view(np.int64))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as few and in order; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parts(group: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(group.combine_chunks().to_batches()):
        raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
        yield part, raw, offsets


def removed_spans(docs: DataFrame, shared: Callable, words: bool, length: int, gram: int, finish: Callable, result: str, id_col: str, text_col: str, most: int = GROUP) -> DataFrame:
    """Apply ``finish`` to each document and its repeated spans.

    shared(groups): from the different segments of each anchor, as (content, block, ord, tie,
    start, anchor's offset, parts) of their first places, the stretches of windows that repeat an
    earlier place: (segment, offset, units).  finish(raw, spans): the result's columns of one
    text, by spans in units.  most: different segments of one anchor that are compared at once.
    """
    rows = dealt(docs, id_col, text_col, spread=True)

    def list_anchors(group: pa.Table) -> pa.Table:
        found = [Units(raw, offsets, words).anchors(length, gram)[1] for _, raw, offsets in parts(group)]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        block = group.column("block")[0].as_py()
        return pa.table([pa.array(h), pa.array(np.full(len(h), block, np.int32)), pa.array(n.astype(np.int64))], names=["h", "block", "n"])

    listed = rows.groupBy("block").applyInArrow(list_anchors, "h bigint, block int, n bigint")
    # One row of each block: an anchor of every document has as many rows as there are blocks.
    stands = F.sum("n").over(Window.partitionBy("h"))
    repeated = listed.withColumn("n", stands).filter("n > 1").select("h", "block", F.ceil(F.col("n") / (4 * most)).cast("int").alias("parts"))

    def send(group: pa.Table, anchors: pa.Table) -> pa.Table:
        order, out, seen = np.argsort(anchors.column("h").to_numpy()), [], {}
        wanted, split = anchors.column("h").to_numpy()[order], anchors.column("parts").to_numpy()[order]
        if not group.num_rows or not len(wanted):
            return pa.Table.from_batches([], schema=_segment)
        block, known, places = group.column("block")[0].as_py(), set(), []
        for part, raw, offsets in parts(group):
            units = Units(raw, offsets, words)
            row, h, anchor, lo, hi = units.anchors(length, gram)
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hits = np.flatnonzero(wanted[at] == h)
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            own = {}
            for r in np.unique(row[hits]).tolist():
                key = (LAST if ids[r] is None else ids[r], tie(raw[offsets[r] : offsets[r + 1]]))
                if key not in known:
                    known.add(key)
                    own[r] = key
            for r, x, p, a, b, n in zip(*[c.tolist() for c in (row[hits], h[hits], anchor[hits], lo[hits], hi[hits], split[at[hits]])], strict=True):
                if r in own:
                    base = int(units.offsets[r])
                    places.append((x, units.content(a, b + length), *own[r], a - base, p - a, n, b - a + length))
        # Alike segments of the block: the first goes on, the others repeat it.
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for place in places:
            before = seen.get(place[:2])
            if before is None or place[2:5] < before[2:5]:
                seen[place[:2]] = place
        for place in places:
            if seen[place[:2]] is not place:
                spans.setdefault(place[2:4], []).append((place[4], place[4] + place[7]))
        out = [(x, seg, block, o, t, a, pre, n) for (x, seg), (_, _, o, t, a, pre, n, _) in seen.items()]
        # Spans travel with the segments, under a key of their own, and pass the next stage as they are.
        out += [(xxhash.xxh64_intdigest(f"{o} {t} {a}") - (1 << 63), None, block, o, t, a, b - a, 1) for (o, t), own_ in spans.items() for a, b in merged(own_)]
        return pa.Table.from_batches([table(out, _segment)])

    segments = rows.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(send, SEGMENT)
    # Alike segments lie in the same part of their anchor.
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("seg"), F.col("parts"))).otherwise(0)
    ordered = segments.repartition("h", part).sortWithinPartitions("h", "seg", "ord", "tie", "start")
    spans = ordered.mapInArrow(lambda batches: by_anchors(batches, shared, words, length, most), SPAN)
    # Windows of anchors in several groups: the first place stays, the others are spans. Spans go by their document and stay as they are.
    place = Window.partitionBy(F.coalesce("w1", "tie"), F.coalesce("w2", "ord")).orderBy("ord", "tie", "start")
    spans = spans.withColumn("rank", F.row_number().over(place)).filter("w1 is null or rank > 1").select("block", "ord", "tie", "start", "stop")

    def end(group: pa.Table, found: pa.Table) -> pa.Table:
        by_doc: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for o, t, a, b in zip(*[found.column(c).to_pylist() for c in ("ord", "tie", "start", "stop")], strict=True):
            by_doc.setdefault((o, t), []).append((a, b))
        ids, out = [], []
        for part, raw, offsets in parts(group) if group.num_rows else ():
            for r, doc_id in enumerate(part.column(part.schema.get_field_index("doc_id")).to_pylist()):
                text = raw[offsets[r] : offsets[r + 1]]
                spans = by_doc.get((LAST if doc_id is None else doc_id, tie(text)), []) if by_doc else []
                ids.append(doc_id)
                out.append(finish(text, merged(spans)))
        kinds = [pa.int64() if " bigint" in c else pa.string() for c in result.split(", ")]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        names = [c.split(" ")[0] for c in result.split(", ")]
        return pa.table([pa.array(ids, pa.int64()), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])

    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(end, f"doc_id bigint, {result}")


def by_anchors(batches: Iterator[pa.RecordBatch], shared: Callable, words: bool, length: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, segment, place) to spans, and to the first windows of groups that are not all of their anchor."""
    out: list[tuple] = []
    groups: list[list[tuple]] = []  # to be compared
    firsts: list[tuple] = []  # different segments of the anchor at hand
    partial: set[tuple] = set()  # segments, by place, of anchors with more than one group
    held, anchor, segment, split, halves = 0, None, None, False, struct.Struct("<qq")

    def windows(first: tuple, repeated: list[tuple[int, int]]) -> Iterator[tuple]:
        """The windows of a segment that repeat nothing in their group."""
        seg, block, o, t, a, _, _ = first
        units = seg.split(b" ") if words else seg
        known = {i for x, n in repeated for i in range(x, x + n - length + 1)}
        for i in range(len(units) - length + 1):
            if i not in known:
                content = b" ".join(units[i : i + length]) if words else units[i : i + length]
                yield block, o, t, a + i, a + i + length, *halves.unpack(hashlib.md5(content, usedforsecurity=False).digest())

    def compare() -> list[tuple]:
        found, again = [], {}
        for first, x, n in shared(groups):
            _, block, o, t, a, _, _ = first
            found.append((block, o, t, a + x, a + x + n, None, None))
            if first[1:5] in partial:
                again.setdefault((first[1:5], first[0]), []).append((x, n))
        for first in (f for group in groups for f in group if f[1:5] in partial):
            found += windows(first, again.get((first[1:5], first[0]), []))
        partial.clear()
        groups.clear()
        return found

    def close() -> int:
        """The group at hand is complete; how many bytes it adds to what is to be compared."""
        if not split and len(firsts) < 2:
            return 0
        groups.append(firsts)
        if split:
            partial.update(f[1:5] for f in firsts)
        return sum(len(f[0]) for f in firsts)

    for batch in batches:
        for h, seg, block, o, t, start, pre, parts_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if h != anchor:
                held += close()
                firsts, anchor, segment, split = [], h, None, parts_ > 1
            if seg is None:
                out.append((block, o, t, start, start + pre, None, None))
            elif seg == segment:
                n = seg.count(b" ") + 1 if words else len(seg)
                out.append((block, o, t, start, start + n, None, None))
            else:
                if len(firsts) >= most:
                    split = True
                    held += close()
                    firsts = []
                segment = seg
                firsts.append((seg, block, o, t, start, pre, parts_))
            if held > 400_000:
                out += compare()
                held = 0
            if len(out) > 20_000:
                yield table(out, _span)
                out = []
    close()
    out += compare()
    if out:
        yield table(out, _span)
